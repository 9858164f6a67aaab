"""Column expressions. Everything here runs inside the JVM unless it lives in ``pixels``."""
