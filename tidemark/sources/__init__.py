"""Bar tables: readers, derivation from events and trades, validation, resampling."""
