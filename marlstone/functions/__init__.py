"""Column functions: parsing of raw text, tagged outcomes, checks of codes."""
