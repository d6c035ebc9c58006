"""Plans of actions: rows that say what would be done. Nothing here touches a file."""
