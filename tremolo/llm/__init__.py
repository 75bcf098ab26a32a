"""Training-data operators (deduplication, filtering, scoring, packing).

Nothing else in the library imports this subpackage."""
