"""Column expressions: messages, URLs, HTML, text."""
