"""Reading documents."""
