"""Full-text search, ranking and document maintenance on Spark DataFrames."""

from lexloom.config import EngineConfig, FuzzyConfig
from lexloom.engine import SearchEngine, create_engine
from lexloom.operators.idset import IdSet
from lexloom.operators.result import ResultHandle

__version__ = "0.1.0"
SearchResult = ResultHandle
__all__ = ["EngineConfig", "FuzzyConfig", "IdSet", "ResultHandle", "SearchEngine", "SearchResult", "create_engine"]
