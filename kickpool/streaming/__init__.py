"""The batch operators applied to streams of landed pages and match rows."""
