"""Image-pair observation analytics over gridded space, as DataFrame operators."""
