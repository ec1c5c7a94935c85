"""Reading host tables and keeping versioned state."""
