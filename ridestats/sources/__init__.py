from .order_star import order_star
from .scratch import discard_staged, process_dir, scratch_dir, stage, unstage
from .sink import write_result
from .star import STAR, load_star, register_star, require_columns, validate_dims

__all__ = [
    "STAR", "discard_staged", "load_star", "order_star", "process_dir", "register_star", "require_columns", "scratch_dir", "stage",
    "unstage", "validate_dims", "write_result",
]
