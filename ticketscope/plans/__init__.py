"""Reports by name, and the export of all of them."""
