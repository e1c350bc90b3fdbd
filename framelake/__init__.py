"""Tables and bulk operators for large collections of JPEG images, on Spark."""
