"""Column functions: calendar, text safety, numbers and labels."""
