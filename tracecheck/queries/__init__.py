"""The registered queries of each part of the library, and the same as SQL."""
