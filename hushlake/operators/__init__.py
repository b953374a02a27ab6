"""DataFrame operators: detection, masking, vault, policy, routing, audit and statistics."""
