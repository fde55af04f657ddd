"""Plan-level helpers: staged tables and skew-tolerant joins."""
