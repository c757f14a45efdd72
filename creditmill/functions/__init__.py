"""Column expressions shared by the operators. All of them run inside the JVM."""
