"""Column functions: text, math and state vocabularies."""
