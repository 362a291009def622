"""Layouts: geography, link paths, trees, graphs, words and timelines."""
