from lavra.streaming.pipelines import deduplicated, enriched, read_stream, run_available, run_closed, sessions, windowed

__all__ = ["deduplicated", "enriched", "read_stream", "run_available", "run_closed", "sessions", "windowed"]
