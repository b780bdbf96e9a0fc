"""Column -> Column helpers; everything stays JVM-side."""
