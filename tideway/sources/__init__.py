"""Input tables and the canonical entities built from them."""
