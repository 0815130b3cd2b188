"""DataFrame to DataFrame operators; thresholds, keys and scopes are arguments."""
