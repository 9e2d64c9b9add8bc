"""Column builders: text, vectors, dictionary mining, frontmatter, code text."""
