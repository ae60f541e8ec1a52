"""Spark jobs over tables of images, graphs and documents."""
