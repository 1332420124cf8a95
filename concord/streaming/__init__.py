from concord.streaming.apply import apply_stream, deduplicate, deduplicate_recent, live_counts, retry_due

__all__ = ["apply_stream", "deduplicate", "deduplicate_recent", "live_counts", "retry_due"]
