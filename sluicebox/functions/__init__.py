"""Column functions: parsing of raw cells, text normalisation, checksums and distances."""
