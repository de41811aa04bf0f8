"""Spark jobs that build, search and check a text corpus for question answering."""
