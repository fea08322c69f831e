"""Models as code in other languages, and the catalogue of queries."""
