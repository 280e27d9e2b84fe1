"""lipimala: DataFrame operators for legacy-encoded and scanned text."""
