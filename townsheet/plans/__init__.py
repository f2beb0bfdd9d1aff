"""Jobs: events, places, lines, facets, quality, reports."""
