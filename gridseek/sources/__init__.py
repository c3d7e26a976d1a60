"""Slides, images, tile lists and feature caches."""
