"""sievekit — training-set quality operators on Spark DataFrames.

Influence scoring (PVI, EL2N), score-driven pruning, diversity selection,
shortcut mining from parse trees and n-grams, and the metrics that report them.
"""

__version__ = "0.1.0"
