"""operators of the card-risk engine."""
