"""End-to-end jobs and the registered queries."""


def load_all():
    """Import every query module so that its ``register`` calls run."""
    from ashgrid.plans import (column_queries, eval_queries, hardened_queries, io_queries, jobs, join_queries,  # noqa: F401
                               pixel_queries, sensor_queries, training_queries)
