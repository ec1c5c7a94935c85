"""Column functions: typed values, normalizers and keyed digests."""
