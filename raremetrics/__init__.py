"""raremetrics: Spark-native analytics for rare, zero-inflated events recorded against effort.

Every public function takes DataFrames plus column names and returns a lazy
DataFrame (or, for model fits, a small fitted-model object whose coefficients
are applied back to DataFrames as column expressions).
"""

__version__ = "0.1.0"
