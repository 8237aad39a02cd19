"""DataFrame-first analytics for collectibles markets."""
