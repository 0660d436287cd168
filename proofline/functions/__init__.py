"""Column functions on text, numbers and places; all of them run inside the JVM."""
