"""Storage and text formats."""
