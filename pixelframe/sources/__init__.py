"""Tables: derived fixtures, readers, writers and schemas."""
