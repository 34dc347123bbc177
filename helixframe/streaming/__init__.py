from helixframe.streaming.stream import run_available, stream_parquet

__all__ = ["run_available", "stream_parquet"]
