"""Training-data operators: near-duplicate joins, sharding, token counts, encoding, dedup, decontamination, quality,
language, web archives and a content-addressed token store.  Nothing else in the library imports this subpackage."""
