"""Column functions: text, anchors, similarity, masking, statistics."""
