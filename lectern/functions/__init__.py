"""Column functions over text and bibliographic metadata."""
