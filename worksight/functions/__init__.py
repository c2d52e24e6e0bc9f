from .columns import clean_double, floor_days, holds, points, round_even
from .geo import grid_cell, haversine_km
from .text import ngrams, tokens

__all__ = ["clean_double", "floor_days", "holds", "points", "round_even",
           "grid_cell", "haversine_km", "ngrams", "tokens"]
