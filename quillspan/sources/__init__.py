"""Where lines come from: archives, folders, document tables."""
