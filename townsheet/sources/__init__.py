"""Readers and adapters: feeds, calendars, pages, schedules."""
