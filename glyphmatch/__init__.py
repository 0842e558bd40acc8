"""Approximate string matching, fuzzy search and string distances on Spark DataFrames."""

from .functions.metrics import seq_dist, seq_sim, text_distance, text_similarity
from .functions.phonetic import phonetic, printable_ascii
from .operators.grams import qgrams, seq_qgrams
from .operators.match import ain, amatch, seq_ain, seq_amatch
from .operators.pairs import pairwise, seq_distmatrix, distance_matrix, similarity_matrix
from .operators.search import afind, extract, grab, grabl

__version__ = "0.1.0"
__all__ = [
    "afind", "ain", "amatch", "extract", "grab", "grabl", "pairwise", "phonetic", "printable_ascii", "qgrams", "seq_ain", "seq_amatch", "seq_dist", "seq_distmatrix", "seq_qgrams", "seq_sim",
    "text_distance", "distance_matrix", "text_similarity", "similarity_matrix",
]
