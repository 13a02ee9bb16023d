"""Physical building blocks: size checks, skew-safe joins, exact tiles and ranks."""
