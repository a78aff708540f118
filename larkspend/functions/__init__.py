"""functions of the card-risk engine."""
