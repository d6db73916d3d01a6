from partcast.sources.tables import Tables

__all__ = ["Tables"]
