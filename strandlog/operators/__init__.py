"""Pure DataFrame to DataFrame operators over change logs and live tables."""
