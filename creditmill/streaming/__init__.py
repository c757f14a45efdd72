"""The idempotent load as a stream of arriving feature files."""
