"""Column -> Column building blocks. All of them run inside the JVM and need no shuffle."""
