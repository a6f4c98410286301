"""The registered queries, one module per family of operators."""

from importlib import import_module

FAMILIES = ["scans", "projections", "scalars", "joining", "aggregating", "sequences", "sampling", "naming", "composites",
            "timeseries", "modelling", "searching", "nearest", "streams", "upkeep",
]


def load() -> None:
    for family in FAMILIES:
        import_module(f"{__name__}.{family}")
