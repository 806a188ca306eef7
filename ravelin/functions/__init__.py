"""Functions on values: names, text, Markdown, JSON repair, string similarity."""
