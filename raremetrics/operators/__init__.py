"""DataFrame → DataFrame operators over the shot-log data model."""
