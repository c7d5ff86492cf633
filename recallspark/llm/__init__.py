"""Training-data operators (web archives, packing, dedup, language, mixing...).

Nothing outside this package imports it; the package may be removed without
affecting the rest of the library.
"""
