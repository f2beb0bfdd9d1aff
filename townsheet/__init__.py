"""Listings analytics as Spark jobs: feeds, places, lines, pages, facets and quality gates."""
