"""Set-at-a-time operators over event data."""
