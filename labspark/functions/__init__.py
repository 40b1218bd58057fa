"""Column builders. Everything here returns a ``Column`` and stays inside code generation."""
