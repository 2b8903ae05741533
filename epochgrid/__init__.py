"""epochgrid: time-aligned epoch tables on Spark."""

__version__ = "0.1.0"

_HOMES = {"ingest": "sources.ingest", "ingest_many": "sources.ingest", "epoch_table": "sources.ingest", "load": "sources.artifact", "EpochDataset": "sources.artifact", "IngestSpec": "spec", "IngestError": "spec", "UsageError": "spec"}


def __getattr__(name: str):
    """The public names, from where they live, when they are first asked for."""
    if name not in _HOMES:
        raise AttributeError(name)
    from importlib import import_module

    return getattr(import_module(f".{_HOMES[name]}", __name__), name)
