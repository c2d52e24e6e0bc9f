"""Risk and anomaly analytics over portfolios of public works, on Spark."""

from .plans.pipeline import Assessment, assess, risk_fusion
from .sources.readers import Dataset, load_dataset

__all__ = ["Assessment", "Dataset", "assess", "load_dataset", "risk_fusion"]
