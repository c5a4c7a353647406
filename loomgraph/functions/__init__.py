from .ids import cut, number_rows, shared_dir  # noqa: F401
