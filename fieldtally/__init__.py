"""fieldtally: ecological survey analytics as Spark DataFrame operators.

Every operator takes and returns DataFrames, stays lazy, and keeps species data
in long sparse form, so the plan is Catalyst's to optimise.
"""

from fieldtally.config import SurveyConfig

__all__ = ["SurveyConfig"]
