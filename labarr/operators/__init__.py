"""Labelled arrays and datasets, and what can be done with them."""

from .dataarray import DataArray
from .dataset import Dataset

__all__ = ["DataArray", "Dataset"]
