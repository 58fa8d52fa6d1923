"""Where rows come from and go to: files and catalog tables."""
