"""Where rows come from and go to: extraction providers, page decoders, templates, job records."""
