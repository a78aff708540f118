"""plans of the card-risk engine."""
