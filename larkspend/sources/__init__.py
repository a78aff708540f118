"""sources of the card-risk engine."""
