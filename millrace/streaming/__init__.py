"""Optional helpers for event streams. The original engine has no streams; these are extensions."""
