"""veilframe: DataFrame operators for privacy-preserving analytics tables."""
