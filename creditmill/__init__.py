"""creditmill: loan-application analytics as Spark DataFrame jobs."""

from creditmill.config import FeatureConfig, LoadConfig

__all__ = ["FeatureConfig", "LoadConfig"]
