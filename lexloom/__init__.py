"""lexloom: citation-grounded retrieval analytics as DataFrame programs."""
