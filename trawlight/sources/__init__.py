"""Tables the operators read and write."""
