from .materialize import materialize, scratch_dir
from .quantiles import exact_quantiles
from .rank import global_rank
from .skew import crowded_keys, lookup_join, salt_of, salts

__all__ = ["materialize", "scratch_dir", "exact_quantiles", "global_rank", "crowded_keys",
           "lookup_join", "salt_of", "salts"]
