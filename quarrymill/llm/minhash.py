"""Near copies by exact Jaccard similarity of 5-word shingles: the library's, with the thresholds of this subpackage."""

from quarrymill.operators.near import WORDS, bands, near_copies, shingles, similarity

__all__ = ["WORDS", "bands", "near_copies", "shingles", "similarity"]
