"""DataFrame-to-DataFrame operators: scan, mask, policy, ordered state, flattening."""
