"""Content-addressed data on Spark: objects, versioned hash-trie maps and chunked arrays as DataFrame operators."""
