"""Pure ``Column -> Column`` expressions. Nothing here starts a job or moves data."""
