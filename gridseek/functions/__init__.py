"""Functions on images and strings."""
